"""Sources and sinks: manifests, corpora, object listings, vocabularies, tensor tables."""
