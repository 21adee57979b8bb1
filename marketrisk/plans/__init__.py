"""Ready-made plans: adapters from the supplied tables and the full feature job."""
