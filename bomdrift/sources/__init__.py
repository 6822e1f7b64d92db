"""Source views and the mapping of the test tables to them."""
