"""See the module names; nothing is re-exported here."""
