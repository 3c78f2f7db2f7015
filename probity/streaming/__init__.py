"""The same scoring on streams: file sources, running totals, windows with late rows, progress sink."""
