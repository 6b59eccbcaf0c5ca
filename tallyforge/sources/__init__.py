"""Readers that turn raw logs and ledgers into canonical usage events."""
