"""RDF terms and SPARQL expressions as columns."""
