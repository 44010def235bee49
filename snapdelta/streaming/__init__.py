"""The engine has batch semantics only; nothing here needs a stream."""
