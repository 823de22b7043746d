"""A file stream of scans. The library's batch operators have no notion of time; this is an extension."""
