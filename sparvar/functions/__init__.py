"""Native column expressions and the few Arrow-batched numeric helpers."""
