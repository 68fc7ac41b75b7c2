"""postern: mail-threat analytics and corpus preparation as Spark DataFrame plans."""
