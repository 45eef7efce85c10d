"""Tables that follow streams of landed rows."""
