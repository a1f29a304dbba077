"""DataFrame -> DataFrame operators, generic over their key columns."""
