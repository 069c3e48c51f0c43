"""Where streams come from and go to."""
