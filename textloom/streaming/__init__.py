"""The same operators on streams: they keep no state, so any of them runs on readStream."""
