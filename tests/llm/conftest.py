"""The session and the data folder come from the tests above."""
