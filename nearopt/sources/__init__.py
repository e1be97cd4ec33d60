"""Where rows come from and results go."""
