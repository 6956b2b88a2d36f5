"""DataFrame operators: ordering, sampling, validation, labels, profiles, sessions, signals."""
