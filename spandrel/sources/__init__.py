"""Where matrices and vectors come from and go to."""
