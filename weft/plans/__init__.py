"""Query plans over the tables, and the catalogue of all queries."""
