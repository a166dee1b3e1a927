"""Plan helpers: spreading, exact ranks, hash-ordered picks, block pairs."""
