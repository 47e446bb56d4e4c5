"""From a YAML pipeline to one lazy DataFrame."""
