"""Where tables come from and where results go."""
