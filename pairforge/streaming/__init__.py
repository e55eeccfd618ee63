"""The stateless operators over streams of dropped files."""
