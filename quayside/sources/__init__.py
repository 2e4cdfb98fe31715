"""Tables, their schemas and roles."""
