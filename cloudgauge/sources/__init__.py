"""Point clouds in PLY and scan projects in XML."""
