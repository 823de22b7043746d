"""Where meshes come from: generators, files, and the streaming inbox's parsers."""
