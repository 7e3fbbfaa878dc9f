"""Evidence analytics on Spark: text, corpus, library, contract, timeline and inventory operators as DataFrame plans."""
