"""Part of claimloom."""
