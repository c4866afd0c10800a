"""Rules with declared dependencies, and scratch tables of iterative plans."""
