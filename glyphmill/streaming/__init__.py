"""Page parts as they arrive: pairs without repeats, and counters, over a stream of files."""
