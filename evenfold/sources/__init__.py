"""Where people tables come from and where groupings go."""
