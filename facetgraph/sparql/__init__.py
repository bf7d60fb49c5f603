"""A SELECT and ASK subset of SPARQL 1.1: parser, policy, and plans over quads."""
