"""Package part; see README.md."""
