"""End-to-end flows and the catalogue of registered queries."""
