"""Live data: range vectors, watermarks, scopes, standing queries, joins of streams."""
