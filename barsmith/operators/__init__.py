"""DataFrame to DataFrame operators over bars."""
