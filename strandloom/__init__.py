"""Haplotype analytics on Spark: phasing, read tagging and modification calling as DataFrame plans."""
