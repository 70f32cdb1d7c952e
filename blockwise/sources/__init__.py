"""Readers, writers and the test-fixture adapters."""
