"""Named queries of the library and their SQL counterparts."""
