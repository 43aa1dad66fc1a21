"""Sources that give the one ordered table of elements."""
