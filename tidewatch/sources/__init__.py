"""Where rows come from: message envelopes, files, the events table, delimited text."""
