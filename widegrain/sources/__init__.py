"""Where tables come from, and what can be learned from them."""
