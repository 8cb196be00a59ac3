"""Column-expression builders. Every function returns a ``Column`` made of
built-in Spark expressions, so it runs inside whole-stage codegen."""
