"""quire: analytics over corpora of paginated, marked-up documents, as Spark plans."""
