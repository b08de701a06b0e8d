"""Structured Streaming: there is no streaming operator to match. The column functions of
``filamento.functions`` are stateless and apply to a streaming frame as they are."""
