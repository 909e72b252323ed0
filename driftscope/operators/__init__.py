"""DataFrame-in, DataFrame-out steps.  Nothing here starts a job."""
