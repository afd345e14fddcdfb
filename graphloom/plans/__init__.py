"""From query text to DataFrame plans: parser, templates and compiler of the SPARQL subset."""
