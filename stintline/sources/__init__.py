"""Sources: bindings onto the relational tables, JSON landings, stored artifacts."""
