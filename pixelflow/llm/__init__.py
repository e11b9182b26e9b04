"""Training-data operators: tokens, quality, language, near copies, URL rules, licences, neighbours and packing."""
