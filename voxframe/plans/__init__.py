"""Input views and the registered queries."""
