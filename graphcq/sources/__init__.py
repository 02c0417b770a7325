"""Where graphs and queries come from, and where graphs and pair stores go."""
