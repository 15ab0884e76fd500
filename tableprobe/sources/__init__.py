"""Reading tables and storing results."""
