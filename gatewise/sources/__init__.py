"""Reading and writing uncertain facts."""
