"""Tables that operators read and write."""
