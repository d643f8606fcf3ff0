"""The size up to which a measured side is broadcast."""

BROADCAST_BYTES = 8 << 20
