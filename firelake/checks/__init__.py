"""Views over the check tables, and every operator as a registered query with its SQL."""
