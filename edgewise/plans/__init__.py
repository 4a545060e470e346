"""Plan shaping shared by the operators: scratch tables, loops, skew."""
