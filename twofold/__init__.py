"""twofold: ensembles of two-part (hurdle) count models as Spark DataFrame jobs."""
