"""granary: text-corpus curation and paired-outcome evaluation as Spark DataFrame plans."""
