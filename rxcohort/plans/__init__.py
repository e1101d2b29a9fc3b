"""How a code list or a dictionary meets a fact table."""
