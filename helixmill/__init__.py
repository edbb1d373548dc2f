"""helixmill: taxonomic-profiling analytics expressed as Spark DataFrame transformations."""
