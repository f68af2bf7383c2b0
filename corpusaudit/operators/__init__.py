"""DataFrame -> DataFrame operators of the audit."""
