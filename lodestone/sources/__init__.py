"""Sources and sinks: source trees, documents, manifests, version-control text, graph files."""
