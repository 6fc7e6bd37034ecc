"""DataFrame operators: usage counts and access-path tests."""
