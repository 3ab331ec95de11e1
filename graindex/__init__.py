"""Roll-ups, matching, similarity and parsing over collections of nested documents, as DataFrame plans."""
