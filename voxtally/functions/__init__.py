"""Column expressions: everything here is evaluated by Catalyst, no Python in tasks."""
