"""Where rows come from and go to: sessions, tables, topics, seed rows and table sinks."""
