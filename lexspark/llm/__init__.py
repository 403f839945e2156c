"""Training-data operators: formatting, tokens, filters, search, language model, de-duplication."""
