"""From text to plans: the workflow language's parser and its compiler to columns, inputs, and the query catalogue."""
