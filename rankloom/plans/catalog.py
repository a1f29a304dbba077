"""Imports every module of named queries and exposes the two tables."""

from . import content_queries, evaluation_queries, feature_queries, point_queries, policy_queries, pose_queries, ranking_queries, registration_queries, source_queries, voxel_queries  # noqa: F401
from .registry import QUERIES, TWINS  # noqa: F401
