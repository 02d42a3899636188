"""Tables, streams of files or of a broker, the JSON tokenizer, and sinks."""
