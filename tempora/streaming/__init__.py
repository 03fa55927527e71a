"""Row-wise checks on streams.

The source of truth is batch; these wrappers only show that the row-wise operators
take a streaming DataFrame unchanged and that duplicates can be found under a
watermark.
"""
