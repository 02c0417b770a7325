"""What is done with answers."""
