"""Table and file sources, sinks, and the helpers every plan uses to read them."""
