"""Readers and writers for manifests, candidate files, meshes and volumes."""
