"""DataFrame operators over a column of HTML."""
