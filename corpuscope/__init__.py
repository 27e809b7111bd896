"""corpuscope: code-corpus indexing, search, log compaction and usage analytics on Spark."""
