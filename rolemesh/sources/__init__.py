"""Tables, vocabularies, text corpora and log lines, read with their schemas; updates of tables as their next state."""
