"""Where changes are kept: manifest, write-ahead log, runs, and the store over them."""
