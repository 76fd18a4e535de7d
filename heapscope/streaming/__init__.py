"""Empty on purpose: a heap dump is one finished file, and no operator here works on a stream."""
