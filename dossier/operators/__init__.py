"""Set-wise operators over announcement tables."""
