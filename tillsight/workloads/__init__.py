"""The registered queries: domain tables derived from the star-schema tables, one query per operator."""
