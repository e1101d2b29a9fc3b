"""Code lists, cohorts, descriptions, utilisation and safety."""
